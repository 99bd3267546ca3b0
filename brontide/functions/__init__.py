"""brontide.functions"""
