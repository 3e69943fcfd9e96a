"""featlake.functions"""
