"""The additive part of the engine over streams."""
