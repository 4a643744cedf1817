"""Column expressions (JVM-side, inside whole-stage codegen)."""
from shotgrid.functions.math import (argmax, batch_size_rule, bce_with_logit, distill_batch_size, hash_index,
                                     kl_rows, linear_schedule, log_softmax, sample_key, softmax, steps_per_epoch)
from shotgrid.functions.text import (answer_word, clean_answer, demo_text, display_label, is_parsed, method_from_file,
                                     metric_title, minimal_pattern, parse_answer, teacher_context)
