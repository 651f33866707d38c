"""DataFrame operators for preparing and scoring corpora of long token sequences."""
