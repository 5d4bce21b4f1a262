"""From a request in words to a plan of pipelines, and the pipelines themselves."""
