"""The gap rules as a Structured Streaming stateful operator, and the queries around it."""
