"""Column-level building blocks: text, URLs, dates, markup, keywords, scores."""
