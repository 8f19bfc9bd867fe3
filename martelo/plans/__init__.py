"""martelo.plans"""
