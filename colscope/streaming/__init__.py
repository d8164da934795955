"""Extensions for streams."""
