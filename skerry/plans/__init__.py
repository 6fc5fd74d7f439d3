"""Reports: what a station asks of its captures and its weather."""
