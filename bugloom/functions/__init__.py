"""Column functions: every one maps Columns to a Column and never shuffles."""
