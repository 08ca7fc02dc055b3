"""llm package."""
