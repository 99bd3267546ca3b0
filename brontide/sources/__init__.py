"""brontide.sources"""
