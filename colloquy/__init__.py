"""colloquy: conversation-dynamics analytics as DataFrame operators on Spark."""
