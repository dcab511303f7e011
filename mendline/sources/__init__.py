"""Reading and writing: wire codecs, batch and stream sources, sinks, shared work folders."""
