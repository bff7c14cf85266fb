"""Training-data operators: filtering, tokenisation, search, packing and formatting at corpus scale."""
