"""martelo.operators"""
