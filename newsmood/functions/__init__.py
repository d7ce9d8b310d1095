"""Column builders: text, dates, URLs, HTML, scores."""
