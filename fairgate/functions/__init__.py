"""fairgate.functions"""
