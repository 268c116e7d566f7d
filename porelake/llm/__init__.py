"""Training-data operators: packing, sharding, near-duplicates, search, classifiers, chat, licences, mixing."""
