from workload import classification, candidates, normalization, reconstruction, certificates, quality, history, review, outputs, layouts  # noqa: F401
