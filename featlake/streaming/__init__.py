"""featlake.streaming"""
