"""loam.functions"""
