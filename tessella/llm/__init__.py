"""Training-data operators: dedup, language, joins, chat, packing, media, mixing, licences, counts."""
