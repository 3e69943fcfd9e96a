"""featlake.operators"""
