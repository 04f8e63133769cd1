"""Set-based operators: a batch of documents in, accepted and rejected rows and new state out."""
