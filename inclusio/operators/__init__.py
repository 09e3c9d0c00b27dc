"""DataFrame-in, DataFrame-out operators: cleaning, features, ranks, folds, encoding, search, metrics, training."""
