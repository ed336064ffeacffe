"""docustrata.plans"""
