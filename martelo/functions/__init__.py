"""martelo.functions"""
