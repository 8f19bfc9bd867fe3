"""martelo.streaming"""
