"""DataFrame to DataFrame operators; each takes ``keys`` and handles all comparisons at once."""
