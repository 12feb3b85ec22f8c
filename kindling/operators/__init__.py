"""DataFrame -> DataFrame operators (cleaning, features, summaries, split, metrics)."""
