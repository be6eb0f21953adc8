"""Online training from streams of documents."""
