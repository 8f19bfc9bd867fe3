"""martelo.sources"""
