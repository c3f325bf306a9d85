"""Column builders: CIGAR, log space, intervals, sequences, call strings."""
