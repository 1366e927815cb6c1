"""Savings levers, action tables and the end-to-end analysis, all over the cells and two log replays."""
