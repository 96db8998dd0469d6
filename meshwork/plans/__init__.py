"""meshwork.plans"""
