"""Composed plans: fallback ladders, deadlines, storyboards."""
