"""From a pipeline's text to a plan: parser, rules, names, types, lowering."""
