"""meshwork.operators"""
