"""spanloom.sources"""
