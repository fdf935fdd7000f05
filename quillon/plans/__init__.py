"""quillon.plans"""
