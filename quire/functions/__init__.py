"""Column functions: geometry of boxes, text and formula cleaning, HTML tables, requests and replies, names."""
