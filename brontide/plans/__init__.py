"""brontide.plans"""
