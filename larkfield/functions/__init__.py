"""Column functions: text, address, phone, web, geography, time and opening hours."""
