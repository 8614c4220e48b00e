"""Multi-operator plans and the skew-safe building blocks they share."""
