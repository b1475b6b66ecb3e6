"""fairgate.operators"""
