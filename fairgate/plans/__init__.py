"""fairgate.plans"""
