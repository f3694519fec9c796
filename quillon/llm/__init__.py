"""Training-data operators: search, mixing, quality, extraction, sketches, language, privacy, URLs, near copies, packing, audit, phrases, chat."""
