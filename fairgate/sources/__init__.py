"""fairgate.sources"""
