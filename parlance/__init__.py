"""Transcript analytics on Spark: segments, speakers, alignment, edits and minutes as DataFrame jobs."""
