"""meshwork.streaming"""
