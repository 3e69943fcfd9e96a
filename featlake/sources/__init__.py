"""featlake.sources"""
