"""featlake.plans"""
