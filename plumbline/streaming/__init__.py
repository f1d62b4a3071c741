"""Extensions for unbounded input. The batch operators need none of this."""
