"""Operators of a pipeline that prepares text for language models. Nothing
outside this subpackage imports it."""
