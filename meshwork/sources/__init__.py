"""meshwork.sources"""
