"""fairgate.streaming"""
