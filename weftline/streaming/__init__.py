"""The same steps on streams, and stateful operators that a stream needs."""
