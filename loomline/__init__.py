"""Short-text classification, retrieval and evaluation as composable DataFrame operators."""
