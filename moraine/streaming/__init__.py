"""Structured Streaming: incremental tails, heartbeat timeouts, dead letters, change feeds."""
