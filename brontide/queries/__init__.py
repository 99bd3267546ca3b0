"""brontide.queries"""
