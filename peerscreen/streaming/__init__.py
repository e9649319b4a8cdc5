"""No stream operators are needed here.

The work is batch by nature: a score compares a part with all peers of its
batch, so it exists only once the batch is complete. The row-level steps
(cutoff, checkpoint isolation, typed conversion of text cells) hold no state and
accept a streaming DataFrame unchanged.
"""
