"""brontide.streaming"""
