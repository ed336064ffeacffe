"""docustrata.operators"""
