"""loam.plans"""
