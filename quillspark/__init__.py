"""quillspark: a PySpark-native engine for feed-style content analytics."""
