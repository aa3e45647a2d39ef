"""Column functions: region predicates, boxes, scripts, numbers, Persian text, reply protocol, digests."""
