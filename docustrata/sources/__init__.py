"""docustrata.sources"""
