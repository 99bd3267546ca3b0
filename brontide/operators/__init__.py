"""brontide.operators"""
