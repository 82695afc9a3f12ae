"""DataFrame operators over samples, batches, payloads and adverts."""
