"""brontide.analytics"""
