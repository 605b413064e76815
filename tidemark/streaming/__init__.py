"""The dialect over unbounded input."""
