"""docustrata.functions"""
