"""Column expressions: text, dates, bands and safe arithmetic."""
