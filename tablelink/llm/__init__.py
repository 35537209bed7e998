"""Operations on training data for language models: joins, search, sharding,
packing, decontamination, classifiers, scans and chat formatting."""
