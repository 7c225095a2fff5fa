"""Vehicle-bus signal discovery as Spark plans over many recording sessions."""
