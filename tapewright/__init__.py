"""tapewright: point-in-time market research as PySpark DataFrame operators."""
