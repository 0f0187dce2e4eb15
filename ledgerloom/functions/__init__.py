"""Scalar functions: cursors, tree states, addresses, compact blocks, reply codes."""
