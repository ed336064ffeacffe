"""docustrata.streaming"""
