"""Step windows, stateful refresh and resumable sinks, for streams and for tables."""
