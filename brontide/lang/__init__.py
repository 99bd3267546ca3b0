"""brontide.lang"""
