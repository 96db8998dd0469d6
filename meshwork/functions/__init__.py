"""meshwork.functions"""
