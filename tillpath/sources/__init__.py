"""Reading feeds and tables, writing tables and reports."""
